"""Writers of track files."""
