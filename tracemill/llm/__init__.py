"""Operators of a pipeline that prepares text for training; nothing else in the package imports them."""
