"""Part of tidepool."""
