"""cohortlab: labelled event tables -> clean, profile, split, assign to clients, train per
client, aggregate, evaluate and compare — every step a Spark DataFrame job."""

__version__ = "0.1.0"
