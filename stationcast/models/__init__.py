"""Model training, selection and scoring with Spark ML."""
