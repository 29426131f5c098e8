"""Part of kinfold."""
