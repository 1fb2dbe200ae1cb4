"""filegrove: file-inventory and content-collection analytics as Spark plans."""
