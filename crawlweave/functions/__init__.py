"""Column-to-Column building blocks; nothing here triggers a job or uses Python workers."""
