"""netquarry: netlist, waveform and partition analytics on Spark DataFrames."""
