"""mediarill: media-catalogue and corpus analytics as Spark jobs."""
