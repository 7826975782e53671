"""The stateless operators on a stream source."""
