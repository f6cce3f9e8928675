"""Export formats. Each writer is a function of a DataFrame and a folder."""
