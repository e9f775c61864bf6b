"""Part of the table-grounded text analytics engine."""
