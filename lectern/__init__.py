"""Lectern: DataFrame operators that turn page layouts and book text into narrated timelines."""
