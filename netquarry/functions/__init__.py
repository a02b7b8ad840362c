"""Functions of the netlist and trace analytics engine."""
