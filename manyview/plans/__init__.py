"""Scenes, configuration, the reconstruction plan and the query catalogue."""
