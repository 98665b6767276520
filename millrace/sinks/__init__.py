"""Ways to publish a flow result."""
