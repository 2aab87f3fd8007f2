"""Part of siftline; see the modules inside."""
