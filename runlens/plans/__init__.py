"""Ready-made queries over the driver tables, and the analysis of a whole corpus."""
