"""Readers: wide ledgers, cell grids, invoice tables and directories, decision logs."""
