"""tidemill: fine-tuning data preparation and its operations analytics on PySpark."""
