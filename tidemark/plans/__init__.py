"""From a configuration to DataFrames."""
