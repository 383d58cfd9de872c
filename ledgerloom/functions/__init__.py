"""Column expressions. Nothing here touches a DataFrame or starts a job."""
