"""tidemill: an analytics workbench expressed as PySpark DataFrame plans."""
