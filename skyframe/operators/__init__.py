"""Relational operators over frames, pixels, stars, catalogues, light curves and header cards."""
