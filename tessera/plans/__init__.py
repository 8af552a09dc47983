"""Query registry and the whole tiling run."""
