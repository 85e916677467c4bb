"""Writers of trees: JSON, HTML, text."""
