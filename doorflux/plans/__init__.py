"""Jobs made of operators: loading, publishing and the dashboard."""
