"""DataFrame operators, generic in their inputs."""
