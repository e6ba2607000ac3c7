"""Delivery-signal analytics on Spark: gates, audits, joins, plans and queues
over tables that hold many repositories, services and runs."""
