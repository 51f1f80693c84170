"""plans of folioflow."""
