"""Reading and writing texts, structured formats, vaults and reports."""
