"""Plan helpers shared by the operators: tables and lineage cuts."""
