"""Readers and writers: calibration, images, masks, point clouds, checkpoints, interchange formats."""
