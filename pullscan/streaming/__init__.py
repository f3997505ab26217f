"""Reviews as files arrive."""
