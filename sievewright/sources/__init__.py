"""Sources: opportunity lines, order files, filing listings and documents."""
