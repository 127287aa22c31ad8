"""Training-data operators over document collections. Nothing outside this subpackage imports it."""
