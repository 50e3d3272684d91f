"""Jobs over bank-statement ledgers."""
