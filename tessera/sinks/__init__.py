"""Writers for tiles and tile descriptions."""
