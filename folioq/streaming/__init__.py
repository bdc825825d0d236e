"""What happens over time: change feeds and expiry."""
