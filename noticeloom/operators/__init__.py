"""DataFrame operators: segmentation, layout, HTML tables, reconciliation, record queries."""
