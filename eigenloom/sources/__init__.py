"""Tables, artifacts and configurations in and out."""
