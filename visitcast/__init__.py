"""visitcast: Spark batch jobs from raw clinic and city records to a daily forecast of visits."""
