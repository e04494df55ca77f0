"""Where pixels come from and go to: tables, image files, generated samples."""
