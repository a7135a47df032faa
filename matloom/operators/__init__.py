"""Part of matloom."""
