"""leadspark: evidence-backed entity resolution, scoring and matching on Spark DataFrames."""
