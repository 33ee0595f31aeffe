"""What is decided when a plan is made: grids and costs."""
