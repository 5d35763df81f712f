"""DataFrame operators over transactions, inputs, outputs and observations."""
