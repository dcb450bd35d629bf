"""Readers of agent logs, exported tables, price lists and roll-up documents."""
