"""Reading and writing recordings and lockfiles."""
