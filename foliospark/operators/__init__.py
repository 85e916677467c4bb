"""Set-based operators over section trees, pages, tables of contents and detected elements."""
