"""Query registries: callables and the equivalent SQL."""
