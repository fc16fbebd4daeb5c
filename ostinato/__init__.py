"""Sound-event interval analytics on Spark: frames to segments, interval algebra, catalogue work and clip plans."""
