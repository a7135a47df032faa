"""Tables as the operators' inputs."""
