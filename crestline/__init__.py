"""Early-trend analysis over event and post data as Spark plans."""
