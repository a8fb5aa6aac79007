"""Column functions: statistics that skip missing values, and the functions of factor expressions."""
