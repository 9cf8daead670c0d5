"""Reading tables into operations, and the store on disk."""
