"""Parameters shared by the registered queries and their SQL."""

K = 10  # neighbours per query
FINE = 10  # fine cells, one per label to start with
GROUPS = 4  # coarse cells, one per group of labels to start with
PARTS = GROUPS  # partitions
PROBES = 2  # partitions searched per query
RATE = 0.2  # routing sample
NEIGHBORS = 30  # sample rows that route a query
LLOYD_STEPS = 2
SWEEP_K = (1, 5, 10)
SWEEP_PROBES = (1, 2, 3, 4)
