"""Reading, writing and making cubes."""
