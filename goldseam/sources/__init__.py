"""Reading trusted sources; storing snapshots, manifests and published versions."""
