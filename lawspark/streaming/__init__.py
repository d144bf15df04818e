"""Laws over streams of snapshots."""
