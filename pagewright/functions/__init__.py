"""Column expressions: URLs, HTML, text repair, viewers and images."""
