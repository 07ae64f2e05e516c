"""DataFrame operators: font safety, change attribution, dataset work, evaluation."""
