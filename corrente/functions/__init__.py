"""What user lambdas see and how their results become Catalyst expressions."""
