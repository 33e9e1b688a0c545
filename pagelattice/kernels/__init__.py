"""Pure numpy kernels over single images: no globals, seeded where random."""
