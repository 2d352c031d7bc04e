"""Repository-risk analytics over fleets of source repositories, as Spark jobs."""
