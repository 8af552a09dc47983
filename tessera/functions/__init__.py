"""Column functions: map units, boxes, tags, geometry."""
