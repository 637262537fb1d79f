"""The report parser on a file stream."""
