"""Column helpers and the small numeric kernels that run inside tasks."""
