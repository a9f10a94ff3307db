"""Column functions; none of them needs Python on the executors."""
