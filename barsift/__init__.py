"""Signal analytics over keyed daily bar panels, written for Spark."""
