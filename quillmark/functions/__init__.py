"""See the package documentation in README.md."""
