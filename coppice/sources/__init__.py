"""Sources and sinks: training frames and stored models."""
