"""The engine as one object: configuration, models, plugins, its store and the facade over them."""
