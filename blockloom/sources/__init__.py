"""Tables, manifests, block providers and sinks."""
