"""Tables, and the views that the operators work on."""
