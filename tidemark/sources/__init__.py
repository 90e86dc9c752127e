"""Readers, and the views that turn trade tables into price panels."""
