"""PySpark engine for collecting, cleaning, linking and reporting on public-notice records."""
