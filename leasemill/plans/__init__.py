"""Named models, reports and data sets built from the operators."""
