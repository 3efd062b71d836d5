"""Reports and jobs composed from the operators; each report is a dict of DataFrames."""
