"""Jobs over readings, points and logs."""
