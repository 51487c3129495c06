"""DataFrame operators over notes and their graph."""
