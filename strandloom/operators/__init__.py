"""DataFrame operators: joins, tables of edit scores, alignment, polishing, training, assembly, simulation."""
